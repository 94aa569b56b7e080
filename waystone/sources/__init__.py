"""waystone.sources"""
