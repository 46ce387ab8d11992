"""plumaria sources"""
