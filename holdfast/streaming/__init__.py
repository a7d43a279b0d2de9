"""holdfast.streaming"""
