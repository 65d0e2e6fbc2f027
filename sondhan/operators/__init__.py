"""sondhan.operators"""
