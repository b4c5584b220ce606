"""Operations on training text. Nothing outside this package imports it."""
