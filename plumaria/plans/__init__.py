"""plumaria plans"""
