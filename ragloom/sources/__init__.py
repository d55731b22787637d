"""ragloom.sources"""
