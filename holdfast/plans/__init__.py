"""holdfast.plans"""
