"""sondhan.plans"""
