"""Operators that prepare text for language models; nothing else in the package imports this one."""
