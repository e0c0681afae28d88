"""Part of arrayloom."""
