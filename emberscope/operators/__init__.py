"""Operators over profiles and what is made of them."""
