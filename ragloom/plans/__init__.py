"""ragloom.plans"""
