"""Training-data operators: DataFrame in, DataFrame out. Nothing else in the library imports them."""
