"""holdfast.functions"""
