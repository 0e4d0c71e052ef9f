"""Jobs here are finite: inputs are listed once, run and done. No streaming operators are in scope."""
