"""foliomill.plans"""
