"""Reading directories into DataFrames and writing trees back."""
