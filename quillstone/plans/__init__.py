"""quillstone.plans"""
