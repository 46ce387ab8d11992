"""plumaria functions"""
