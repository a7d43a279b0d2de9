"""holdfast.sources"""
