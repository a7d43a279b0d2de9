"""holdfast.operators"""
