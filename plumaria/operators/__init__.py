"""plumaria operators"""
