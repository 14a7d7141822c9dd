"""valorum.plans"""
