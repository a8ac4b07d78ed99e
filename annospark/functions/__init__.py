"""annospark.functions"""
