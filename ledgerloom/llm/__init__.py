"""Operations on training data at corpus scale; nothing else in the library imports this subpackage."""
