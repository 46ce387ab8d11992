"""plumaria streaming"""
