"""sondhan.sources"""
