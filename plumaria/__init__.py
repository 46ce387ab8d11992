"""plumaria """
