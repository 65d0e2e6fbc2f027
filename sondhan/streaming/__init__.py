"""sondhan.streaming"""
