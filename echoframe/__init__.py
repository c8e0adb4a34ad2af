"""Echoframe: duplicate detection over tables of text and source code, on Spark DataFrames."""
