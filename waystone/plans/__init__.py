"""waystone.plans"""
