"""Training-data pipeline operators (toxicity, decontamination, packing, ...).

Nothing else in the library imports this subpackage.
"""
