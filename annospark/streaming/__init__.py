"""annospark.streaming"""
