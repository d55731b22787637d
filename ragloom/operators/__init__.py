"""ragloom.operators"""
