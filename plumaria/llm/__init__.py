"""plumaria llm"""
