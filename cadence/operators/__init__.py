"""Panel operators: pure, lazy DataFrame -> DataFrame functions."""
