"""gradus.streaming"""
