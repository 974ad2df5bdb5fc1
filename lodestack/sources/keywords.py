"""Keyword lists, fixed values. Two entries of the first list are two words long and so match no single token."""

KEYWORDS = {
    "rust": (
        "as, use, extern crate, break, const, continue, crate, else, if, if let, enum, extern, false, fn, for, if, impl, in, "
        "for, let, loop, match, mod, move, mut, pub, impl, ref, return, Self, self, static, struct, super, trait, true, type, "
        "unsafe, use, where, while, abstract, alignof, become, box, do, final, macro, offsetof, override, priv, proc, pure, "
        "sizeof, typeof, unsized, virtual, yield"
    ).split(", "),
    "java": (
        "abstract assert boolean break byte case catch char class const continue default do double else enum extends final "
        "finally float for goto if implements import instanceof int interface long native new package private protected "
        "public return short static strictfp super switch synchronized this throw throws transient try void volatile while"
    ).split(),
    "c_sharp": (
        "abstract as base bool break byte case catch char checked class const continue decimal default delegate do double "
        "else enum event explicit extern false finally fixed float for foreach goto if implicit in int interface internal "
        "is lock long namespace new null object operator out override params private protected public readonly ref return "
        "sbyte sealed short sizeof stackalloc static string struct switch this throw true try typeof uint ulong unchecked "
        "unsafe ushort using virtual void volatile while add alias ascending async await by descending dynamic equals from "
        "get global group into join let nameof notnull on orderby partial remove select set unmanaged value var when where "
        "yield"
    ).split(),
}
