"""Column functions: text normalisation, predicates, parsers and diagram style decoding."""
