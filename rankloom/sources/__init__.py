"""Readers, writers and the views the registered queries run on."""
