"""foliomill.operators"""
