"""Operators that prepare a text corpus for training language models. Nothing else in the package imports this one."""
