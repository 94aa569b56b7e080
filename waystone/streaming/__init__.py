"""waystone.streaming"""
