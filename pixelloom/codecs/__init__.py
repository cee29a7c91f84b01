"""One function for each codec: bytes and options in, a Surface out, DecodeError where there is none."""
