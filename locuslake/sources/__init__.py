"""Readers and writers of the file formats the operators start from and end in."""
