"""foliomill.functions"""
