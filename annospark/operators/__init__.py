"""annospark.operators"""
