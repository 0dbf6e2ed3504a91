"""Perl, XS and POD sources to rows of the graph."""
