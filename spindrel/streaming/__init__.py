"""spindrel.streaming"""
