"""Readers, payload decoders and exports."""
