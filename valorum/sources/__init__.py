"""valorum.sources"""
