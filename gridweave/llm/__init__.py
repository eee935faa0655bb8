"""Operators for preparing training text: counting, scoring, packing, matching and filtering documents."""
