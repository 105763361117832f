"""Source front end: token trees of script files and the facts read from them."""
