"""Column functions: names, magnet links, bencode, HTML."""
