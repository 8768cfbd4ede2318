"""Operators: DataFrame in, DataFrame out, no action unless the name says so."""
