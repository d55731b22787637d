"""ragloom.functions"""
