"""foliomill.streaming"""
