"""spindrel.sources"""
