"""Readers for capture, ledger, analysis and alias files; writers for reports."""
