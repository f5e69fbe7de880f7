"""spindrel.functions"""
