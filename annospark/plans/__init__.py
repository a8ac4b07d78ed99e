"""annospark.plans"""
