"""Digests of the canonical forms (``licences.canonical``) of full licence texts.

Taken from the texts of Debian's common licences (with, without and up to the line "end of terms and conditions" where it
has one) and from licence files of published packages, in several wrappings and with their usual titles: a copyright line
is dropped by how a line begins, so that the wrapping of a text can change its canonical form.
"""

# Name, SHA-256 of the canonical form.
DIGESTS = (
    ("Apache-2.0", "3cadc7d4f362979643c5bb255c4c9d67312a93c3c4af0667dd141c2b18817454"),
    ("Apache-2.0", "3f3112fe3656909b8bf79c7ec7988f83a43b47aeadf2b7d62205aaf449d9f1be"),
    ("Apache-2.0", "78d3f28b94db35e5ee3c6b75e4c9cad4ac1d46e490ae2773ed1a523a412fe8f2"),
    ("Apache-2.0", "7ca36485262b91fa2d8f956a02f40aabe526450e50646e673c7dc86a7f5747fd"),
    ("Apache-2.0", "897827a39b585da3545e2ee6d2b38872c32e2a6f0cc9a1d32ac28a99f9cc5155"),
    ("Apache-2.0", "93c166a0858ad5fc8ee860a087818d84b9afe007ed085d189dd32c12f841d3c6"),
    ("Apache-2.0", "9b0ce6c89bfb5c197dd116103fd62760fec76094f96a334872896a4e3d26da76"),
    ("Apache-2.0", "a59acb355ce555a1fa4343147138e7cf6fa02a8efa49c4b10b8a5b9e9ace8911"),
    ("Apache-2.0", "e48104441e69502923d21a6370f79d0687ac869c266defceb024b36d8f617a4c"),
    ("Artistic-1.0-Perl", "93aa47d57763801ed6e6a6591d4d4049a2c46794df90838023ceade56b569da0"),
    ("BSD-2-Clause", "032f33a9fad178d38ba062bc5f6e47fde5eb48f13d4c8895fe1360e806c83a69"),
    ("BSD-2-Clause", "957c3854a3d72e069e7f5e48857ad9ab76135f14c70d60fa9ec6ef9a928d45dd"),
    ("BSD-2-Clause", "a56fee4b2f66331ed54da4950ef9c9391453fd1490b4d8ea202bc29683bcbd30"),
    ("BSD-2-Clause", "bf4cd629bb8a70e349537e8ca530dc88576938ec375a2ede8054a0ebaf7ae836"),
    ("BSD-2-Clause", "eda2ad636e738f6a26a2fea902bb734ee48c789a5b40035b8db3659bd951e5bc"),
    ("BSD-3-Clause", "1238550805feaeec7ac6f60c2a1b7b3828c3fb1e9d9d52c718c3b75c7b5ff98e"),
    ("BSD-3-Clause", "9b83d3dee0616d07b82a272dd9bf5134a9f402b750f5ee6188458073b0a32ff2"),
    ("BSD-3-Clause", "cf77ee3d20f4076cecdb58fc53aa7204c9f5c0651621abbc85e028f5b2ffa6b4"),
    ("CC0-1.0", "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e"),
    ("GFDL-1.2", "20c42435f0d621b5e3c63d0ff06a50a23d6bbc4b5274294936600894fe520981"),
    ("GFDL-1.3", "ef88b56ac896f0404014264904aea07f30ee784b66907d259c7d030e88185171"),
    ("GPL-1.0", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),
    ("GPL-1.0", "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70"),
    ("GPL-1.0", "9e12a40a9b22c45d116f19e1746b08ea0b853519de3e03ceb780f2a36d5f388c"),
    ("GPL-2.0", "a1e7ba14d8d85807f384435b77f91e925decc43da128311c991c4f2337e44017"),
    ("GPL-2.0", "b866f5427b78991db8012466b32f51c907f5e974fde5129a47372d0d0552e3a1"),
    ("GPL-2.0", "e4d14510e41435c3eb12c255b72546a3cb9943f06f209c72bc30a19095b08999"),
    ("GPL-3.0", "364cabcec52b5e7ebeb09d58650c2a3a9b227883aef84cede6f7c2a50cbbb574"),
    ("GPL-3.0", "f37d587507fc579524cb06d1130d5899891a978ee008cfc033b3b4d95da28bee"),
    ("GPL-3.0", "f7bb29d9a31c3a1a68ccff0d8d9053350dc0b10b52b62d46d0f2e36a41e32975"),
    ("ISC", "23651ce8a73abaa8fad9143faad3fca843b5de6baf345008f65c453ea5685fb1"),
    ("ISC", "40e6eb51c3b409d93549806b55b249c261dab149d19b56cc163624f39a08b1db"),
    ("ISC", "42946511a83e28f311705b31247163141fd1157d2c9b9923c5292ca9d1299c63"),
    ("ISC", "5fb628af212d6618ceee2210c60a5dee79b64f7c54d6cb2c7b40f19369024708"),
    ("ISC", "6e9dc1cd727a12354f4cef293d9d285ed81ed312d597842774d1120ac62a6dc6"),
    ("ISC", "94b4e9f723d13830ec6a47b422738caee264943af1673fa32782cefd730ffc82"),
    ("ISC", "dcec6d2fdf7cfb76315416b661ea23a66e68248a5f6ef023a5d2199c4671748c"),
    ("ISC", "e00f31f158e77a60e7375307e014eeb17754967f6d6757d019567221315db4e1"),
    ("ISC", "fa224876c62df0b2fc8bde54e6682fed261c5669e98fcbcd614754b5f1b8e4e2"),
    ("LGPL-2.0", "b4114daa3dfa52e27e78b2c4e17acd58bf4381e812762f4ded0bcb8eabd1092c"),
    ("LGPL-2.0", "e0de5033b5ad2a24c0a1a8b04f09e33038ffa62d2bef7178de2a3c6f5d56f499"),
    ("LGPL-2.0", "ff773d8d898dfc51ae2dbf3baa20700673e8ceb153b13d26c525af34a59adf0c"),
    ("LGPL-2.1", "294fb9ec58649c7eb0cf90fc2900ac1b28b82fb6da9d40d7599d6b7d399d4d2e"),
    ("LGPL-2.1", "963f79d48038eed98d8341c84d8d3b765e99508a738d00654c0112f70a7c370c"),
    ("LGPL-2.1", "9bf9c99aeafbdbccd7456a00d574699e3deb41868375496cacbf170be719bebd"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MIT", "00a5c934b705d69594539c6a37a1105192217249a30fe111a375560a492639c9"),
    ("MIT", "0cf21bdfd1964a97a8615e128534845826afbc887edc95aa5c925cbf64386b5c"),
    ("MIT", "35a446201226de6b27cfb7106d0f6c697f63bfeac2913dcf89024911e66ef164"),
    ("MIT", "5d01a1651a4c284dfbbf1500c7a5c7abb115387c003fbedd1e4624fe9b90b141"),
    ("MIT", "6733127d88b7d3bd59c42da120690dbdff1e658acf3fa3e2448092079ad6999a"),
    ("MIT", "6ad3654379e72bbdf8478d5c90fb1e2525aba033fbe675e0ef2248aac67c0f6f"),
    ("MIT", "6c833965e9ca4cf8095655005226f24fe8bf7b1605dbe513204837a7371fa127"),
    ("MPL-1.1", "5a2ee9be26bce49ef38bc723c38721221e1291d8780f4d2a288b44877f836b60"),
    ("MPL-2.0", "8f0473f9c917c507827dca355168119bb065ca1a9dab0e366988bcdba5fa039b"),
    ("MPL-2.0", "c49558a4d97ef4086252de225beb9f2a2ff0bfdff790221e73f212e1a7a0418f"),
    ("Unlicense", "fd1b07be5f4f94926b6ea4df3943b05ab90c1a1f3b1a3d574ae7ab58bca58fff"),
)
