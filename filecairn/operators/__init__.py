"""Inventory operators: frames in, frames out."""
