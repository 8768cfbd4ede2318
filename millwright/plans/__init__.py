"""The user-level analyses, composed from the operators."""
