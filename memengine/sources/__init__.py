"""Readers, dump flatteners and static dimensions."""
