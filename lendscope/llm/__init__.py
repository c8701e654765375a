"""Operators for preparing training text: packing, decontamination, filters, exact text joins, formatting, codes."""
