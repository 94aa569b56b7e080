"""waystone.operators"""
