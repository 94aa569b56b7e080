"""waystone.functions"""
