"""sondhan.functions"""
