"""foliomill.sources"""
