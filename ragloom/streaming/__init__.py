"""ragloom.streaming"""
