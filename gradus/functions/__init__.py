"""gradus.functions"""
