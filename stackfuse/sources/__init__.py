"""Tables, image files and their writers."""
