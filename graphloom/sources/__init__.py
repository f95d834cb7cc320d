"""Readers that bring foreign edge tables into two string columns."""
