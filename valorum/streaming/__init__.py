"""valorum.streaming"""
