"""gradus.sources"""
