"""annospark.sources"""
