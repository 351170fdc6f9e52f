"""Spark-native data work for retrieval-based toxicity mitigation.

DataFrame-in / DataFrame-out operators over prompts, generations, attribute
scores, key -> next-token datastores and next-token distributions.
"""
