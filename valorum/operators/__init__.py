"""valorum.operators"""
