"""gradus.operators"""
