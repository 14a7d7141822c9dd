"""valorum.functions"""
