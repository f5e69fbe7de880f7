"""spindrel.operators"""
