"""spindrel.plans"""
