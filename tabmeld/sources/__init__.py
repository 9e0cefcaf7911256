"""File catalogue, dialect probe and scans."""
